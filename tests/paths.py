"""Where the tests read their tables."""

SF_SMALL = "/root/testdata/sf0.001"
