"""Operators for preparing training data, one module per problem."""
