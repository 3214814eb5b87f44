"""Document-content jobs on Spark: structure, workbooks, slides, plans, logs and reports."""
