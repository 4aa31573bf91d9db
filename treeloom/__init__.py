"""Tree-document analytics on Spark: node tables, edit distance, diffs and patches."""
