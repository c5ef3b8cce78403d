"""Query plans over the tables: views, composed evaluation, and the registered queries."""
