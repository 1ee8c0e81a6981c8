"""inkwell: ordered document blocks to clean, tagged, validated records, on Spark DataFrames."""
