"""Where the tests' tables lie."""

SF = "/root/testdata/sf0.01"
