"""Purchase-decision analytics and data-processing operators for Spark."""
