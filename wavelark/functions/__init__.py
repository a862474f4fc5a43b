"""Column functions: four-state logic, time."""
