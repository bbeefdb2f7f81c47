"""Submit script: raw CSV to validated, cleaned Parquet."""

from sondeflow.plans.materialize import main

if __name__ == "__main__":
    main()
