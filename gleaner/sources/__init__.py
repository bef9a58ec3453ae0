"""Reading and writing items, features, routed sets and fitted models."""
