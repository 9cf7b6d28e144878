"""Where the repository and the given tables are."""

import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TESTDATA = os.environ.get("TESTDATA", "/root/testdata")
