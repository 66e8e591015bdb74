"""Readers and writers for the files the analyses exchange."""
