"""Streams of requests and of turns. An addition of this engine; batch and stream share the same transformations."""
