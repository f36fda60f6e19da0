"""gridtally: interval statistics, set algebra and registry analytics on Spark."""
