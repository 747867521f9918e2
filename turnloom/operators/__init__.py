"""Operators over conversations: validate, normalize, render, encode, parse, convert, and text generators."""
