"""The log relation and the plans that every operator is built from."""
