"""Reading and writing the formats the operators work on."""
