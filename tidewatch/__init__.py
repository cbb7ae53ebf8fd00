"""tidewatch: trend analytics over large article, post and event tables, as PySpark jobs."""
