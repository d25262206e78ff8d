"""Reports, input views and the query registry."""
