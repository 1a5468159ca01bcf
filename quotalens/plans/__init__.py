"""End-to-end audits and the catalogue of registered queries."""
