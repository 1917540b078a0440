"""Streaming: the reference has none of its own; new text files can be fed through the same operators."""
