"""Helpers that shape physical plans: staging, sizing, salting."""
