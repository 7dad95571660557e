"""Operators for large training-data pipelines. Modules are imported one by one, so that workers load only what they run."""
