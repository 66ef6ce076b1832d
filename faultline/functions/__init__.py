"""Column functions and the building blocks shared by the operators."""
