import os
import pkg.a as a
from pkg.a import Box, helper as assist
from . import noimports


def local():
    return os.getcwd()


def caller(n):
    local()
    Box(n)
    assist(n)
    a.helper(n)
    if n:
        return caller(n - 1)
    return noimports.alone()
