"""HTML captures: tree, Markdown, quoted history, headers. Plain Python, called from Arrow passes."""
