"""DataFrame operators: each takes frames and parameters (with an explicit `now` where time matters) and returns one."""
