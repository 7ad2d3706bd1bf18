"""Ready-made plans over the sample warehouse tables, each with an equivalent SQL text where one exists."""
