"""From a query to a plan, and the registered queries."""
