"""Plan-level recipes shared by the operators: durable cuts, skew, ordered passes."""
