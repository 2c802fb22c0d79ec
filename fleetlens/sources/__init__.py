"""Where tables, query texts and stored results come from and go to."""
