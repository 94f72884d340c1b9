"""Where the tests find their tables. A module of its own name: several folders have a conftest."""

import os

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem documents labels".split()
