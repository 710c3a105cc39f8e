"""Multi-step plans: conversion, reconstruction, verification."""
