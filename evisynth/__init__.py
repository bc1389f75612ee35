"""Evidence-synthesis analytics as DataFrame -> DataFrame operators on Spark."""
