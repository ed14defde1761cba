"""Column expressions: NULL rules, recodes and cause-code flags."""
