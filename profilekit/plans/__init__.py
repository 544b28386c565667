"""Operators put together: feature engineering, the batch run and questions to its result."""
