"""Checks of proposed edits (original, replacement): plain Python over two strings, run by Arrow batches in operators.edits.

They need look-behind at what was matched before, multisets and positions, which no built-in expression has. Offsets are code points.
"""
