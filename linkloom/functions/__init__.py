"""Column functions: what the engine computes per value, without Python on the executors unless a module says so."""
