"""End-to-end feature pipelines composed from the operators."""
