"""Entry script for `spark-submit`; see `tallybrook.plans.jobs`."""

from tallybrook.plans.jobs import main

if __name__ == "__main__":
    main()
