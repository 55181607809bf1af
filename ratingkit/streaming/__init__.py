"""Streaming.

The reference has no stream source, watermark, event-time window or state, so no streaming
operator is built.  Every fitted model here (encoders, neighbour tables, factor tables) is
applied with stateless left joins against static tables, which Structured Streaming runs as
stream-static joins, so a ``readStream`` of pairs can be scored with the same ``transform``.
"""
