"""Analytics over container-packaged artwork projects, written as Spark jobs."""
