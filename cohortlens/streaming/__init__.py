"""Streaming entry points.

The reference has no streaming logic; its scoring (M21) and the scalar
cleaning functions are row-wise, so they apply unchanged to a streaming
DataFrame.  No state, watermark or window is involved.
"""
