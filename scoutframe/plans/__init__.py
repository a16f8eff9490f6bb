"""The batch valuation plan and its binding to the star-schema test tables."""
