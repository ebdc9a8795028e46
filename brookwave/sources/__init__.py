"""Readers of media bytes: sniffing, framing and box walks."""
