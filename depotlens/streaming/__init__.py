"""Structured Streaming: cold-chain sensor readings and request bursts."""
