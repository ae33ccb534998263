"""Analysis operators: each is one or a few aggregations over Spark and small algebra on their result."""
