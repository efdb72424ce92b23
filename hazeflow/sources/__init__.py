"""Decoding and scanning of landed data."""
