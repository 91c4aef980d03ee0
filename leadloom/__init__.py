"""leadloom: table-in, table-out Spark operators for lead scoring and text corpora."""
