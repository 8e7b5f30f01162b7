"""Test suite."""
