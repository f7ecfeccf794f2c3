"""The driver's test tables as a fleet: registered queries and the SQL that checks them."""
