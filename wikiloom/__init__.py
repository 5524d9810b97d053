"""Wiki corpus jobs on Spark: links, page tree, Markdown and publishing as DataFrame operators."""
