"""docsieve: relational operators for inspecting and cleaning document collections on Spark."""
