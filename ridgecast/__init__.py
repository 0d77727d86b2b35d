"""ridgecast: radio-coverage and site-planning analytics as Spark DataFrame jobs."""
