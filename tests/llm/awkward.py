"""Documents that are easily mishandled."""

#: A missing id, missing and empty texts, blank ones, ties, repeated rows, a long text.
AWKWARD = [
    (None, "one two three four five six seven eight nine ten"), (1, None), (2, ""), (3, " \t\r\n"),
    (4, "word"), (5, "same text here"), (6, "same text here"), (6, "same text here"),
    (7, "α β γ δ ε ζ η θ ι κ λ μ"), (8, "long word " * 150_000), (9, "x" * 300_000),
    (10, "first line\nsecond line\nfirst line\n\n\nsecond line"), (11, None), (12, ""),
]
