"""Relations: where they come from and how a rule finds them."""
