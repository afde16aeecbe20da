"""Column functions. Arguments are read several times, so pass a plain column or a lambda variable."""
