"""gleanspark: auditing text corpora and model outputs with Spark plans."""
