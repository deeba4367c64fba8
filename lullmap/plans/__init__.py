"""Plan building blocks shared by the operators: ordered splits and scratch storage."""
