"""Training-data operators over whole corpora (one module per operator).

Nothing else in the library imports this subpackage.  ``queries`` lists the
registered queries and their SQL; every other module is one operator with its
own general interface.
"""
