"""The operators of the survey as queries over the test tables, by family."""
