"""Input views, registered queries and their reference SQL over the shared tables."""
