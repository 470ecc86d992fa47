"""End-to-end plans and the query / oracle registry."""
