"""tracemill: trace analytics and corpus operators expressed as Spark plans."""
