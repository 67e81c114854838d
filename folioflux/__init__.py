"""folioflux: page lines to reviewed records, as Spark DataFrames."""
