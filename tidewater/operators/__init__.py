"""DataFrame-to-DataFrame operators of the warehouse's batch and stateless stream jobs."""
