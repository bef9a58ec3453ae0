"""DataFrame -> DataFrame operators and estimators."""
