"""Input views, corpus templates, reports and the registered queries."""
