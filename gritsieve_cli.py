"""The commands for ``spark-submit --py-files gritsieve.zip gritsieve_cli.py scan …``."""

import sys

from gritsieve.plans.cli import main

if __name__ == "__main__":
    sys.exit(main())
