"""Tables that follow a growing folder of raw files."""

from .tables import daily_means, latest, raw_stream, repeated_timestamps, update

__all__ = ["daily_means", "latest", "raw_stream", "repeated_timestamps", "update"]
