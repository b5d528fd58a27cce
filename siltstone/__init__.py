"""Quality-aware analytics on Spark: rules, relevance guards and workflows over wide fact tables."""
