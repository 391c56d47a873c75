"""Operators on whole relations and documents: tabularizing, schemas, validation, generation, find and replace."""
