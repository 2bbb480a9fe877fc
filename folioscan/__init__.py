"""Full-text document search on Spark: index, keyword queries ranked by weighted BM25, highlighted passages."""
