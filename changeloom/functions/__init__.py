"""Column functions: no data moves, all stay in whole-stage code."""
