"""Reading and writing runs and write-ahead logs."""
