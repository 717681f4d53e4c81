"""Where the tests find the given tables."""

SF = "/root/testdata/sf0.001"
