"""Jobs: each takes DataFrames of landed or recorded rows and returns one."""
