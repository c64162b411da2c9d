"""furlong: race analytics and corpus preparation as Spark jobs."""
