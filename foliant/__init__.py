"""Foliant: catalog building, entity resolution, ranking and discussion analytics on Spark."""
