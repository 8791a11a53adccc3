"""Where the benchmark tables lie (a module of its own: conftest files shadow one another)."""

SF_DIR = "/root/testdata/sf0.001"
