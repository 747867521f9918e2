"""The whole way of a request, as one chain of transformations."""
