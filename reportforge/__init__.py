"""reportforge: report triage and corpus analytics expressed as Spark DataFrame jobs."""
