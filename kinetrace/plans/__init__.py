"""Query language, planning, execution."""
