"""The pipeline language's front end: text to tokens to a tree. Nothing here needs Spark."""
