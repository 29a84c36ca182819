"""Jobs, fixture views, registered queries and their reference SQL."""
